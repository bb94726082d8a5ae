"""Vocabulary of the domain as data: fixed values, in their natural order."""

from __future__ import annotations


# ---- fixed values: file types ----

MIME_CATEGORY = {
    "application/pdf": "DOCUMENT",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "DOCUMENT",
    "text/plain": "DOCUMENT",
    "text/csv": "DOCUMENT",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "DOCUMENT",
    "application/vnd.ms-excel": "DOCUMENT",
    "image/jpeg": "IMAGE",
    "image/png": "IMAGE",
    "image/tiff": "IMAGE",
    "image/bmp": "IMAGE",
    "video/mp4": "VIDEO",
    "video/x-msvideo": "VIDEO",
    "video/quicktime": "VIDEO",
    "application/json": "STRUCTURED",
}
EXTENSION_MIME = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".txt": "text/plain",
    ".csv": "text/csv",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".xls": "application/vnd.ms-excel",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
    ".bmp": "image/bmp",
    ".mp4": "video/mp4",
    ".avi": "video/x-msvideo",
    ".mov": "video/quicktime",
    ".json": "application/json",
}

# ---- fixed values: abbreviations (general, then regional, which win) ----

ABBREVIATIONS = {
    "cod": "cause of death",
    "mod": "manner of death",
    "tod": "time of death",
    "pmi": "post-mortem interval",
    "doa": "dead on arrival",
    "gsw": "gunshot wound",
    "bft": "blunt force trauma",
    "sft": "sharp force trauma",
    "mvca": "motor vehicle collision accident",
    "mva": "motor vehicle accident",
    "ant": "anterior",
    "post": "posterior",
    "lat": "lateral",
    "med": "medial",
    "sup": "superior",
    "inf": "inferior",
    "rt": "right",
    "lt": "left",
    "bilat": "bilateral",
    "htn": "hypertension",
    "dm": "diabetes mellitus",
    "cad": "coronary artery disease",
    "mi": "myocardial infarction",
    "cva": "cerebrovascular accident",
    "copd": "chronic obstructive pulmonary disease",
    "pe": "pulmonary embolism",
    "dvt": "deep vein thrombosis",
    "ards": "acute respiratory distress syndrome",
    "tbi": "traumatic brain injury",
    "sdh": "subdural hematoma",
    "edh": "epidural hematoma",
    "sah": "subarachnoid hemorrhage",
    "ich": "intracerebral hemorrhage",
    "bac": "blood alcohol concentration",
    "etoh": "ethanol",
    "thc": "tetrahydrocannabinol",
    "bzo": "benzodiazepine",
    "opi": "opiate",
    "amp": "amphetamine",
    "meth": "methamphetamine",
    "pcp": "phencyclidine",
    "coc": "cocaine",
    "ng/ml": "nanograms per milliliter",
    "mg/dl": "milligrams per deciliter",
    "ug/l": "micrograms per liter",
    "mlc": "medico-legal case",
    "ipc": "Indian Penal Code",
    "crpc": "Code of Criminal Procedure",
    "fsl": "forensic science laboratory",
    "cfsl": "central forensic science laboratory",
    "dfs": "directorate of forensic science",
    "pmo": "post-mortem office",
    "cmo": "chief medical officer",
    "smo": "senior medical officer",
    "jmfc": "judicial magistrate first class",
    "io": "investigating officer",
    "sho": "station house officer",
    "ps": "police station",
    "fir": "first information report",
    "ddo": "dead body disposal order",
    "inquest": "inquest report",
    "pm": "post-mortem",
    "pmr": "post-mortem report",
    "pme": "post-mortem examination",
    "alp": "aluminum phosphide",
    "opc": "organophosphorus compound",
    "opcp": "organophosphorus compound poisoning",
    "rta": "road traffic accident",
    "rtc": "road traffic collision",
    "sia": "self-inflicted injury attempt",
    "npa": "non-poisonous animal",
    "dob": "date of birth",
    "dod": "date of death",
    "doe": "date of examination",
    "dot": "date of treatment",
    "acs": "acute coronary syndrome",
    "chf": "congestive heart failure",
    "ckd": "chronic kidney disease",
    "cld": "chronic liver disease",
    "dcmp": "dilated cardiomyopathy",
    "lvh": "left ventricular hypertrophy",
    "rvf": "right ventricular failure",
    "lvf": "left ventricular failure",
    "mods": "multi-organ dysfunction syndrome",
    "dic": "disseminated intravascular coagulation",
    "gcs": "Glasgow Coma Scale",
    "rbs": "random blood sugar",
    "ecg": "electrocardiogram",
    "ct": "computed tomography",
    "mri": "magnetic resonance imaging",
    "usg": "ultrasonography",
}

# ---- fixed values: canonical terms ----

INJURY_TYPES = {
    "cut": "laceration",
    "cuts": "laceration",
    "slash": "laceration",
    "tear": "laceration",
    "bruise": "contusion",
    "bruising": "contusion",
    "ecchymosis": "contusion",
    "hematoma": "contusion",
    "break": "fracture",
    "broken": "fracture",
    "crack": "fracture",
    "cracked": "fracture",
    "burn": "thermal_burn",
    "burns": "thermal_burn",
    "scald": "thermal_burn",
    "scrape": "abrasion",
    "scratch": "abrasion",
    "graze": "abrasion",
    "stab": "puncture_wound",
    "pierce": "puncture_wound",
    "puncture": "puncture_wound",
    "bullet": "gunshot_wound",
    "gunshot": "gunshot_wound",
    "shooting": "gunshot_wound",
    "strangle": "ligature_strangulation",
    "suffocate": "asphyxiation",
    "drown": "drowning",
    "drowning": "drowning",
    "poison": "toxicological",
    "overdose": "toxicological",
}
BODY_REGIONS = {
    "head": "head",
    "skull": "head",
    "cranium": "head",
    "face": "head",
    "forehead": "head",
    "temple": "head",
    "neck": "neck",
    "throat": "neck",
    "cervical": "neck",
    "chest": "thorax",
    "thorax": "thorax",
    "rib": "thorax",
    "ribs": "thorax",
    "lung": "thorax",
    "heart": "thorax",
    "abdomen": "abdomen",
    "stomach": "abdomen",
    "belly": "abdomen",
    "liver": "abdomen",
    "kidney": "abdomen",
    "spleen": "abdomen",
    "pelvis": "pelvis",
    "hip": "pelvis",
    "groin": "pelvis",
    "arm": "upper_extremity",
    "shoulder": "upper_extremity",
    "elbow": "upper_extremity",
    "wrist": "upper_extremity",
    "hand": "upper_extremity",
    "finger": "upper_extremity",
    "leg": "lower_extremity",
    "thigh": "lower_extremity",
    "knee": "lower_extremity",
    "ankle": "lower_extremity",
    "foot": "lower_extremity",
    "toe": "lower_extremity",
    "back": "posterior_trunk",
    "spine": "posterior_trunk",
    "lumbar": "posterior_trunk",
}
MANNERS = {
    "natural": "natural",
    "accident": "accidental",
    "accidental": "accidental",
    "suicide": "suicide",
    "homicide": "homicide",
    "murder": "homicide",
    "undetermined": "undetermined",
    "pending": "pending_investigation",
    "unknown": "undetermined",
}

# ---- fixed values: ordered classes, the first with a word in the text counts ----

SEVERITY = {
    "FATAL": ["fatal", "lethal", "incompatible with life", "death", "died", "succumbed", "expired"],
    "CRITICAL": ["critical", "life-threatening", "major organ", "massive hemorrhage", "multiple organ", "brain injury"],
    "SEVERE": ["severe", "extensive", "deep wound", "compound fracture", "major vessel", "organ damage", "grievous"],
    "MODERATE": ["moderate", "significant", "deep laceration", "contusion", "tissue damage"],
    "MINOR": ["minor", "simple", "small", "non-grievous", "abrasion", "superficial laceration"],
    "SUPERFICIAL": ["superficial", "minor scratch", "slight", "small abrasion", "insignificant", "trivial"],
}
DECOMPOSITION = {
    "SKELETONIZATION": ["skeletonization", "skeletonized", "skeletal remains", "bones only", "dry remains", "complete skeletonization"],
    "ADVANCED_DECAY": ["advanced decay", "advanced decomposition", "most soft tissue lost", "mummification", "adipocere", "saponification", "partial skeletonization"],
    "ACTIVE_DECAY": ["active decay", "maggots", "larval activity", "skin slippage", "hair slippage", "liquefaction", "tissue breakdown", "foul smell", "putrefied"],
    "BLOAT": ["bloating", "bloated", "distension", "distended", "gas formation", "swollen", "purging", "marbling", "protruding tongue", "foul odor"],
    "EARLY_DECOMPOSITION": ["greenish discoloration", "early decomposition", "greenish discolouration", "green patch", "early putrefaction", "slight odor"],
    "FRESH": ["no decomposition", "fresh", "well preserved", "no putrefactive changes", "body well maintained"],
}
WOUND_AGE = {
    "OLD": ["old", "healed", "scar", "cicatrix", "fibrosis", "organized", "chronic"],
    "HEALING": ["healing", "granulation", "scab", "crusted", "yellowish", "brownish", "resolving"],
    "RECENT": ["recent", "clotted", "dried blood", "swollen", "inflammatory", "reddish", "edematous"],
    "FRESH": ["fresh", "bleeding", "active bleeding", "raw", "bright red", "no healing", "recent"],
}
CAUSES = {
    "NATURAL_DISEASE": ["natural", "disease", "cardiac", "myocardial", "coronary", "stroke", "cerebrovascular", "pulmonary embolism", "pneumonia", "cancer"],
    "POISONING": ["poison", "toxic", "overdose", "ingestion", "organophosph", "cyanide", "aluminum phosphide", "drug", "chemical"],
    "ASPHYXIA": ["asphyx", "strangul", "hanging", "suffoc", "throttling", "smothering", "choking", "ligature", "compression of neck"],
    "DROWNING": ["drowning", "submersion", "immersion", "water in lungs", "diatom"],
    "BURNS": ["burn", "scald", "thermal", "flame", "kerosene", "acid", "chemical burn"],
    "BLUNT_FORCE": ["blunt force", "blunt trauma", "head injury", "craniocerebral", "fall", "assault", "vehicular", "rta", "road traffic"],
    "SHARP_FORCE": ["sharp force", "stab", "incised", "cut throat", "slash", "chop", "hack"],
    "FIREARM": ["firearm", "gunshot", "bullet", "shooting", "rifle", "pistol"],
    "ELECTROCUTION": ["electrocution", "electric", "lightning", "current", "shock"],
    "MULTIPLE_INJURIES": ["multiple injuries", "polytrauma", "combined"],
}
FIELD_INJURY = {
    "laceration": ["lacerat", "tear", "cut"],
    "contusion": ["contusion", "bruise", "ecchymosis"],
    "abrasion": ["abrasion", "scrape", "graze", "scratch"],
    "fracture": ["fracture", "broken", "crack"],
    "incised_wound": ["incised", "slash"],
    "puncture_wound": ["puncture", "stab", "pierce"],
    "gunshot_wound": ["gunshot", "bullet", "firearm", "gsw"],
    "burn": ["burn", "scald"],
    "ligature_mark": ["ligature", "strangle", "hanging"],
}
FIELD_REGION = {
    "head": ["head", "skull", "scalp", "forehead", "temple", "face", "cranium"],
    "neck": ["neck", "throat", "cervical"],
    "thorax": ["chest", "thorax", "rib", "lung", "heart", "sternum"],
    "abdomen": ["abdomen", "stomach", "belly", "liver", "kidney", "spleen"],
    "upper_extremity": ["arm", "hand", "finger", "wrist", "elbow", "shoulder", "forearm"],
    "lower_extremity": ["leg", "foot", "toe", "ankle", "knee", "thigh", "shin"],
    "pelvis": ["pelvis", "hip", "groin"],
    "back": ["back", "spine", "lumbar", "dorsal"],
}

# ---- fixed values: synonyms, by category ----

SYNONYMS = {
    'anatomical': {'breastbone': 'sternum', 'kneecap': 'patella', 'shoulder blade': 'scapula', 'collarbone': 'clavicle', 'shinbone': 'tibia', 'thighbone': 'femur', 'backbone': 'vertebral column', 'windpipe': 'trachea', 'gullet': 'esophagus', 'food pipe': 'esophagus', 'voice box': 'larynx', "adam's apple": 'thyroid cartilage', 'funny bone': 'olecranon', 'tailbone': 'coccyx', 'jawbone': 'mandible', 'cheekbone': 'zygomatic bone', 'skull cap': 'calvarium', 'temple bone': 'temporal bone', 'rib cage': 'thoracic cage', 'hip bone': 'innominate bone', 'womb': 'uterus', 'belly button': 'umbilicus', 'navel': 'umbilicus', 'armpit': 'axilla', 'groin area': 'inguinal region', 'palm': 'palmar surface', 'sole': 'plantar surface', 'eardrum': 'tympanic membrane'},
    'injury': {'black eye': 'periorbital ecchymosis', 'blood clot': 'hematoma', 'bleeding': 'hemorrhage', 'internal bleeding': 'internal hemorrhage', 'blood in chest': 'hemothorax', 'blood in abdomen': 'hemoperitoneum', 'blood in skull': 'intracranial hemorrhage', 'skull fracture': 'cranial fracture', 'broken neck': 'cervical spine fracture', 'broken back': 'vertebral fracture', 'collapsed lung': 'pneumothorax', 'dislocated': 'dislocation', 'swelling': 'edema', 'pus': 'purulent discharge', 'stitches': 'sutures', 'scar': 'cicatrix', 'rope mark': 'ligature mark', 'nail mark': 'crescentic abrasion', 'bite mark': 'patterned contusion', 'defence wound': 'defense wound', 'hesitation cut': 'hesitation wound', 'self-inflicted': 'self-inflicted wound', 'blunt injury': 'blunt force trauma', 'sharp injury': 'sharp force trauma'},
    'medical': {'heart attack': 'myocardial infarction', 'stroke': 'cerebrovascular accident', 'fit': 'seizure', 'fits': 'seizures', 'sugar disease': 'diabetes mellitus', 'blood pressure': 'hypertension', 'high bp': 'hypertension', 'low bp': 'hypotension', 'kidney failure': 'renal failure', 'liver failure': 'hepatic failure', 'lung infection': 'pneumonia', 'blood poisoning': 'septicemia', 'water in lungs': 'pulmonary edema', 'clot in lungs': 'pulmonary embolism', 'clot in legs': 'deep vein thrombosis', 'brain death': 'cerebral death', 'fatty liver': 'hepatic steatosis', 'enlarged heart': 'cardiomegaly', 'enlarged liver': 'hepatomegaly', 'enlarged spleen': 'splenomegaly', 'hardening of arteries': 'atherosclerosis', 'blockage': 'occlusion', 'narrowing': 'stenosis', 'inflammation': 'inflammatory process', 'infection': 'infectious process', 'cancer': 'malignant neoplasm', 'tumor': 'neoplasm', 'abscess': 'localized collection of pus'},
    'forensic': {'rigor': 'rigor mortis', 'lividity': 'livor mortis', 'post mortem lividity': 'livor mortis', 'hypostasis': 'livor mortis', 'death stiffness': 'rigor mortis', 'body stiffness': 'rigor mortis', 'decomposition': 'putrefaction', 'decomposed body': 'putrefied remains', 'bloating': 'post-mortem bloating', 'maggots': 'larval infestation', 'insect activity': 'entomological activity', 'marbling': 'post-mortem marbling', 'skin slip': 'post-mortem skin slippage', 'green discoloration': 'post-mortem discoloration', 'purging': 'post-mortem purging', 'adipocere': 'saponification', 'mummification': 'desiccation', 'brought dead': 'dead on arrival', 'brought in dead': 'dead on arrival', 'found dead': 'discovered deceased', 'unnatural death': 'non-natural death', 'foul play': 'suspicious circumstances', 'unknown body': 'unidentified remains'},
    'indian_english': {'giddiness': 'dizziness', 'giddy': 'dizzy', 'loose motion': 'diarrhea', 'loose motions': 'diarrhea', 'passing motion': 'defecation', 'blood in motion': 'hematochezia', 'blood vomit': 'hematemesis', 'vomiting blood': 'hematemesis', 'difficulty in breathing': 'dyspnea', 'breathlessness': 'dyspnea', 'weakness': 'asthenia', 'body ache': 'myalgia', 'chest pain': 'thoracic pain', 'stomach pain': 'abdominal pain', 'head injury': 'craniocerebral injury', 'consuming poison': 'ingestion of poison', 'consumed poison': 'ingested poison', 'poison case': 'suspected poisoning', 'hanging body': 'body found suspended', 'burn injury': 'thermal injury', 'road accident': 'road traffic accident', 'rta': 'road traffic accident'},
}

# ---- fixed values: toxicology ----

SUBSTANCES = {
    "ethyl alcohol": "ethanol",
    "alcohol": "ethanol",
    "etoh": "ethanol",
    "ethyl": "ethanol",
    "blood alcohol": "ethanol",
    "marijuana": "cannabis",
    "thc": "cannabis",
    "ganja": "cannabis",
    "bhang": "cannabis",
    "charas": "cannabis",
    "heroin": "diacetylmorphine",
    "smack": "diacetylmorphine",
    "brown sugar": "diacetylmorphine",
    "morphine sulfate": "morphine",
    "mscontin": "morphine",
    "diazepam": "diazepam",
    "valium": "diazepam",
    "alprazolam": "alprazolam",
    "xanax": "alprazolam",
    "lorazepam": "lorazepam",
    "ativan": "lorazepam",
    "meth": "methamphetamine",
    "crystal meth": "methamphetamine",
    "coke": "cocaine",
    "crack": "cocaine",
    "rat poison": "aluminum_phosphide",
    "celphos": "aluminum_phosphide",
    "sulphas": "aluminum_phosphide",
    "kuchla": "strychnine",
    "nux vomica": "strychnine",
    "dhatura": "datura_stramonium",
    "datura": "datura_stramonium",
    "oleander": "nerium_oleander",
    "kaner": "nerium_oleander",
    "opium": "opiate",
    "afeem": "opiate",
    "sleeping pills": "barbiturate",
    "phenobarbitone": "phenobarbital",
    "organo phosphorus": "organophosphate",
    "op compound": "organophosphate",
    "op poison": "organophosphate",
    "insecticide": "organophosphate",
    "pesticide": "organophosphate",
    "potassium cyanide": "cyanide",
    "kcn": "cyanide",
    "white phosphorus": "phosphorus",
    "yellow phosphorus": "phosphorus",
    "carbolic acid": "phenol",
    "lysol": "phenol",
    "copper sulphate": "copper_sulfate",
    "neela thotha": "copper_sulfate",
    "zinc phosphide": "zinc_phosphide",
    "paraquat": "paraquat",
    "endosulfan": "endosulfan",
    "malathion": "malathion",
    "chlorpyrifos": "chlorpyrifos",
    "monocrotophos": "monocrotophos",
    "phorate": "phorate",
}
METABOLITES = {
    "6-monoacetylmorphine": "diacetylmorphine",
    "6-mam": "diacetylmorphine",
    "benzoylecgonine": "cocaine",
    "ecgonine methyl ester": "cocaine",
    "nordiazepam": "diazepam",
    "oxazepam": "diazepam",
    "alpha-hydroxyalprazolam": "alprazolam",
    "norfentanyl": "fentanyl",
    "noroxycodone": "oxycodone",
    "eddp": "methadone",
    "amphetamine": "methamphetamine",
    "11-nor-9-carboxy-thc": "cannabis",
    "thc-cooh": "cannabis",
    "cotinine": "nicotine",
    "acetaldehyde": "ethanol",
}
#: substance -> (lethal, toxic, therapeutic), each an inclusive range
LEVELS = {
    "ethanol": ((400.0, 9999.0), (100.0, 400.0), (0.0, 50.0)),
    "morphine": ((500.0, 9999.0), (200.0, 500.0), (10.0, 70.0)),
    "diazepam": ((5000.0, 9999.0), (2000.0, 5000.0), (100.0, 1000.0)),
    "phenobarbital": ((80.0, 9999.0), (50.0, 80.0), (10.0, 40.0)),
    "cocaine": ((500.0, 9999.0), (100.0, 500.0), (0.0, 0.0)),
    "methamphetamine": ((500.0, 9999.0), (200.0, 500.0), (10.0, 50.0)),
    "cyanide": ((3.0, 9999.0), (0.5, 3.0), (0.0, 0.0)),
    "organophosphate": ((0.0, 9999.0), (0.0, 0.0), (0.0, 0.0)),
}
TOX_UNITS = {
    "mg/dl": "mg/dL",
    "mg/100ml": "mg/dL",
    "ng/ml": "ng/mL",
    "ug/ml": "ug/mL",
    "mg/l": "mg/L",
    "ug/l": "ug/L",
    "g/dl": "g/dL",
    "g/l": "g/L",
    "mmol/l": "mmol/L",
    "%": "%",
    "percent": "%",
    "ppm": "ppm",
}
TOX_RESULTS = {
    "POSITIVE": ["positive", "pos", "+", "detected", "present"],
    "NEGATIVE": ["negative", "neg", "-", "not detected", "absent", "nil", "none"],
    "TRACE": ["trace", "minimal"],
    "PENDING": ["pending", "awaited"],
}
TOX_STEMS = [
    "ethanol",
    "alcohol",
    "opiate",
    "opioid",
    "cannabis",
    "thc",
    "barbiturate",
    "benzodiazepine",
    "amphetamine",
    "cocaine",
    "organophosph",
    "cyanide",
    "arsenic",
    "mercury",
    "lead",
    "aluminium phosphide",
    "oleander",
    "dhatura",
    "strychnine",
]
DRUG_CLASSES = {
    "ethanol": ["depressant", "unscheduled", "alcohol"],
    "morphine": ["opioid", "Schedule II", "analgesic"],
    "diacetylmorphine": ["opioid", "Schedule I", "narcotic"],
    "cocaine": ["stimulant", "Schedule II", "local_anesthetic"],
    "methamphetamine": ["stimulant", "Schedule II", "amphetamine"],
    "cannabis": ["cannabinoid", "Schedule I", "hallucinogen"],
    "diazepam": ["benzodiazepine", "Schedule IV", "anxiolytic"],
    "alprazolam": ["benzodiazepine", "Schedule IV", "anxiolytic"],
    "phenobarbital": ["barbiturate", "Schedule IV", "anticonvulsant"],
    "fentanyl": ["opioid", "Schedule II", "analgesic"],
    "organophosphate": ["cholinesterase_inhibitor", "pesticide", "insecticide"],
    "aluminum_phosphide": ["fumigant", "pesticide", "rodenticide"],
    "cyanide": ["metabolic_poison", "restricted", "industrial_chemical"],
    "strychnine": ["convulsant", "restricted", "rodenticide"],
    "paraquat": ["herbicide", "pesticide", "herbicide"],
}

# ---- fixed values: code systems (code, name) and anatomy (system, region) ----


ICD_INJURIES = {
    "head injury": ("S09.90", "Unspecified injury of head"),
    "craniocerebral injury": ("S06.9", "Intracranial injury, unspecified"),
    "skull fracture": ("S02.9", "Fracture of skull, unspecified"),
    "cranial fracture": ("S02.9", "Fracture of skull, unspecified"),
    "subdural hematoma": ("S06.5", "Traumatic subdural hemorrhage"),
    "epidural hematoma": ("S06.4", "Epidural hemorrhage"),
    "subarachnoid hemorrhage": ("S06.6", "Traumatic subarachnoid hemorrhage"),
    "intracerebral hemorrhage": ("S06.3", "Focal traumatic brain injury"),
    "brain contusion": ("S06.3", "Focal traumatic brain injury"),
    "concussion": ("S06.0", "Concussion"),
    "traumatic brain injury": ("S06.9", "Intracranial injury, unspecified"),
    "facial fracture": ("S02.9", "Fracture of facial bones"),
    "mandible fracture": ("S02.6", "Fracture of mandible"),
    "nasal fracture": ("S02.2", "Fracture of nasal bones"),
    "neck injury": ("S19.9", "Unspecified injury of neck"),
    "cervical spine fracture": ("S12.9", "Fracture of cervical vertebra"),
    "hyoid fracture": ("S12.8", "Fracture of other cervical vertebra"),
    "strangulation": ("T71.1", "Asphyxiation due to strangulation"),
    "ligature strangulation": ("T71.1", "Asphyxiation due to strangulation"),
    "hanging": ("T71.0", "Asphyxiation due to hanging"),
    "rib fracture": ("S22.3", "Fracture of rib"),
    "rib fractures": ("S22.4", "Multiple fractures of ribs"),
    "sternal fracture": ("S22.2", "Fracture of sternum"),
    "hemothorax": ("S27.1", "Traumatic hemothorax"),
    "pneumothorax": ("S27.0", "Traumatic pneumothorax"),
    "cardiac contusion": ("S26.0", "Injury of heart"),
    "lung contusion": ("S27.3", "Contusion of lung"),
    "flail chest": ("S22.5", "Flail chest"),
    "liver laceration": ("S36.1", "Injury of liver"),
    "splenic rupture": ("S36.0", "Injury of spleen"),
    "kidney injury": ("S37.0", "Injury of kidney"),
    "intestinal perforation": ("S36.4", "Injury of small intestine"),
    "mesenteric tear": ("S35.2", "Injury of mesenteric vessels"),
    "femur fracture": ("S72.9", "Fracture of femur, unspecified"),
    "tibia fracture": ("S82.2", "Fracture of shaft of tibia"),
    "humerus fracture": ("S42.3", "Fracture of shaft of humerus"),
    "radius fracture": ("S52.5", "Fracture of lower end of radius"),
    "pelvic fracture": ("S32.8", "Fracture of pelvis"),
    "vertebral fracture": ("S32.0", "Fracture of lumbar vertebra"),
    "laceration": ("T14.1", "Open wound of unspecified body region"),
    "contusion": ("T14.0", "Superficial injury of unspecified body region"),
    "abrasion": ("T14.0", "Superficial injury of unspecified body region"),
    "incised wound": ("T14.1", "Open wound of unspecified body region"),
    "puncture wound": ("T14.1", "Open wound of unspecified body region"),
    "gunshot wound": ("T14.1", "Open wound by firearm"),
    "stab wound": ("T14.1", "Open wound by sharp object"),
    "burn": ("T30.0", "Burn of unspecified body region"),
    "thermal burn": ("T30.0", "Burn of unspecified body region"),
    "chemical burn": ("T30.4", "Corrosion of unspecified body region"),
    "electrical burn": ("T75.4", "Effects of electric current"),
    "periorbital ecchymosis": ("S00.1", "Contusion of eyelid"),
    "defense wound": ("T14.1", "Defense wound of upper extremity"),
    "ligature mark": ("T71", "Asphyxiation due to ligature"),
}
ICD_CAUSES = {
    "myocardial infarction": ("I21.9", "Acute myocardial infarction, unspecified"),
    "coronary artery disease": ("I25.1", "Atherosclerotic heart disease"),
    "pulmonary embolism": ("I26.9", "Pulmonary embolism without acute cor pulmonale"),
    "cerebrovascular accident": ("I64", "Stroke, not specified"),
    "hypertension": ("I10", "Essential hypertension"),
    "pneumonia": ("J18.9", "Pneumonia, unspecified organism"),
    "septicemia": ("A41.9", "Sepsis, unspecified organism"),
    "asphyxia": ("T71.9", "Asphyxiation, unspecified"),
    "drowning": ("T75.1", "Drowning and nonfatal submersion"),
    "poisoning": ("T65.9", "Toxic effect of unspecified substance"),
    "organophosphate poisoning": ("T60.0", "Toxic effect of organophosphorus insecticides"),
    "cyanide poisoning": ("T65.0", "Toxic effect of cyanides"),
    "aluminum phosphide poisoning": ("T57.1", "Toxic effect of phosphorus"),
    "alcohol poisoning": ("T51.0", "Toxic effect of ethanol"),
    "opiate overdose": ("T40.2", "Poisoning by other opioids"),
    "blunt force trauma": ("T14.9", "Injury, unspecified"),
    "sharp force trauma": ("T14.1", "Open wound, unspecified"),
    "hemorrhagic shock": ("R57.1", "Hypovolemic shock"),
    "multiple injuries": ("T07", "Multiple injuries, unspecified"),
    "electrocution": ("T75.4", "Effects of electric current"),
    "burns": ("T30", "Burns, unspecified"),
    "heat stroke": ("T67.0", "Heatstroke and sunstroke"),
    "hypothermia": ("T68", "Hypothermia"),
    "starvation": ("T73.0", "Starvation"),
    "natural disease": ("R99", "Other ill-defined causes of mortality"),
}
ANATOMY = {
    "head": ["musculoskeletal", "head"],
    "skull": ["musculoskeletal", "head"],
    "brain": ["nervous", "head"],
    "face": ["musculoskeletal", "head"],
    "neck": ["musculoskeletal", "neck"],
    "trachea": ["respiratory", "neck"],
    "larynx": ["respiratory", "neck"],
    "hyoid": ["musculoskeletal", "neck"],
    "thorax": ["musculoskeletal", "thorax"],
    "heart": ["cardiovascular", "thorax"],
    "lungs": ["respiratory", "thorax"],
    "sternum": ["musculoskeletal", "thorax"],
    "ribs": ["musculoskeletal", "thorax"],
    "abdomen": ["musculoskeletal", "abdomen"],
    "liver": ["digestive", "abdomen"],
    "spleen": ["lymphatic", "abdomen"],
    "kidney": ["urinary", "abdomen"],
    "stomach": ["digestive", "abdomen"],
    "intestine": ["digestive", "abdomen"],
    "pancreas": ["digestive", "abdomen"],
    "aorta": ["cardiovascular", "thorax"],
    "pelvis": ["musculoskeletal", "pelvis"],
    "uterus": ["reproductive", "pelvis"],
    "femur": ["musculoskeletal", "lower_extremity"],
    "tibia": ["musculoskeletal", "lower_extremity"],
    "humerus": ["musculoskeletal", "upper_extremity"],
    "spine": ["musculoskeletal", "back"],
}
ANATOMY_TERMS = [
    "skull",
    "brain",
    "heart",
    "liver",
    "lung",
    "kidney",
    "spleen",
    "stomach",
    "intestine",
    "pancreas",
    "trachea",
    "esophagus",
    "aorta",
    "femur",
    "sternum",
    "vertebra",
    "pelvis",
    "scapula",
    "hyoid",
    "thyroid",
]
ORGANS = ["brain", "heart", "lungs?", "liver", "kidneys?", "spleen", "stomach", "intestines?", "pancreas", "uterus", "bladder"]
INJURY_STEMS = [
    "lacerat",
    "contusion",
    "abrasion",
    "fracture",
    "wound",
    "bruise",
    "ecchymosis",
    "hematoma",
    "incised",
    "puncture",
    "gunshot",
    "burn",
    "ligature",
    "strangulation",
]

# ---- fixed values: units (factor to the target unit), aliases, confidence factors ----

#: source -> (target, factor, offset); fahrenheit has its own formula
CONVERSIONS = {
    "fahrenheit": ("celsius", 5 / 9, -32 * 5 / 9),
    "kelvin": ("celsius", 1.0, -273.15),
    "inches": ("centimeters", 2.54, 0.0),
    "feet": ("centimeters", 30.48, 0.0),
    "yards": ("meters", 0.9144, 0.0),
    "miles": ("kilometers", 1.60934, 0.0),
    "lbs": ("kilograms", 0.453592, 0.0),
    "pounds": ("kilograms", 0.453592, 0.0),
    "ounces": ("grams", 28.3495, 0.0),
    "stones": ("kilograms", 6.35029, 0.0),
    "gallons": ("liters", 3.78541, 0.0),
    "quarts": ("liters", 0.946353, 0.0),
    "fluid_ounces": ("milliliters", 29.5735, 0.0),
    "fl_oz": ("milliliters", 29.5735, 0.0),
}
UNIT_ALIASES = {
    'f': 'fahrenheit',
    '°f': 'fahrenheit',
    'deg f': 'fahrenheit',
    'c': 'celsius',
    '°c': 'celsius',
    'deg c': 'celsius',
    'k': 'kelvin',
    'in': 'inches',
    'inch': 'inches',
    '"': 'inches',
    'ft': 'feet',
    'foot': 'feet',
    "'": 'feet',
    'yd': 'yards',
    'yard': 'yards',
    'mi': 'miles',
    'mile': 'miles',
    'lb': 'lbs',
    'pound': 'pounds',
    'oz': 'ounces',
    'ounce': 'ounces',
    'gal': 'gallons',
    'gallon': 'gallons',
    'cm': 'centimeters',
    'centimeter': 'centimeters',
    'm': 'meters',
    'meter': 'meters',
    'km': 'kilometers',
    'kilometer': 'kilometers',
    'kg': 'kilograms',
    'kilogram': 'kilograms',
    'g': 'grams',
    'gram': 'grams',
    'l': 'liters',
    'liter': 'liters',
    'ml': 'milliliters',
    'milliliter': 'milliliters',
}
CONFIDENCE_FACTORS = {"EXACT_MATCH": 1.0, "FUZZY_MATCH": 0.9, "INFERRED": 0.7, "DEFAULT_VALUE": 0.5, "VALIDATED": 1.05, "ONTOLOGY_MAPPED": 1.02}
STAGE_CODES = {"none": 0, "mild": 1, "moderate": 2, "advanced": 3, "fixed": 4, "complete": 5}
TZ_HOURS = {"UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "IST": 5, "JST": 9, "CET": 1, "CEST": 2, "AEST": 10}
