"""Evidence-shaped views over the star-schema tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bind
from ..session import bound_batches, deal, spread
from ..storage import broadcast_if_small, materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(on: str, values: list[str], last: str | None = None) -> str:
    """CASE over on % n with one text per remainder."""
    n = len(values)
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE CAST({on} % {n} AS INT) {arms} ELSE '{values[-1]}' END"


#: view -> (tables that it reads, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {
    "evidence": (
        ["orders"],
        f"""SELECT o_orderkey AS id, o_custkey AS case_id,
        CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS status,
        {_case('o_orderkey', ['DOCUMENT', 'IMAGE', 'VIDEO', 'STRUCTURED'])} AS category,
        CAST(floor(o_totalprice) AS BIGINT) AS file_size, o_orderkey % 17 = 0 AS is_deleted, o_orderdate AS created_at,
        concat('item_', CAST(o_orderkey AS STRING), {_case('o_orderkey', ['.pdf', '.DOCX', '.txt', '.tar.gz', '.jpg', '.mp4', '', '.json', '.Csv'])}) AS filename,
        {_case('o_orderkey', ['application/pdf', 'application/octet-stream', 'text/html', 'image/png', 'video/mp4'])} AS declared,
        {_case('o_orderkey', ['255044462D312E37', '504B0304', '89504E470D0A1A0A', '0000001866747970', '52494646', 'FFD8FFE0', '424D3604', ''])} AS head_hex
        FROM {{orders}}""",
    ),
    "normalizations": (
        ["lineitem"],
        """SELECT l_orderkey AS evidence_id, l_linenumber AS attempt, l_partkey * 100000 + l_suppkey AS ref, l_shipdate AS created_at,
        CASE WHEN l_returnflag = 'R' THEN 'COMPLETED' WHEN l_returnflag = 'A' THEN 'PARTIAL'
             WHEN l_linestatus = 'F' THEN 'IN_PROGRESS' ELSE 'FAILED' END AS status,
        l_discount AS quality, l_tax AS confidence FROM {lineitem}""",
    ),
    "reports": (
        ["orders"],
        f"""SELECT o_orderkey AS id, concat(
        'PM No: PM/', CAST(o_orderkey % 997 AS STRING), '/2024', chr(10),
        'Name of deceased: ', {_case('o_orderkey', ['Asha Rao', 'John Q Public', 'M Iyer', 'Lena Katz', 'Omar Said'])}, chr(10),
        'Age: ', CAST(o_orderkey % 160 AS STRING), ' years', chr(10),
        'Sex: ', {_case('o_orderkey', ['Male', 'F', 'female'])}, chr(10),
        'Cause of Death: ', {_case('o_orderkey', ['Blunt force trauma', 'Hemorrhagic shock due to stab wound', 'Asphyxia by hanging', 'Myocardial infarction', 'Organophosphate poisoning', 'Gunshot wound of chest', 'Drowning'])}, chr(10), chr(10),
        'Manner of Death: ', {_case('o_orderkey', ['Homicide', 'Suicide', 'Accident', 'natural', 'Pending'])}, chr(10),
        'Time of Death: ', {_case('o_orderkey', ['about 04:00', '6 to 8 hours before examination'])}, chr(10),
        'Date: ', CAST(1 + o_orderkey % 28 AS STRING), '/0', CAST(1 + o_orderkey % 9 AS STRING), '/2024', chr(10),
        'Injury No. 1: ', {_case('o_orderkey', ['deep laceration over scalp 3 x 2 cm', 'fatal incised wound of neck, fresh', 'small abrasion on left knee 12 mm', 'healed scar of forearm', 'contusion of chest 4.5 cm x 2 cm, reddish', 'severe burn of abdomen'])}, chr(10),
        'Injury No. 2: ', {_case('o_orderkey', ['compound fracture of femur', 'ligature mark around neck, brownish', 'bruise over back', 'no further marks'])}, chr(10),
        'Opinion: ', {_case('o_orderkey', ['consistent with the above', 'body bloated with marbling', 'active decay with maggots'])}, chr(10),
        'Ethanol: ', {_case('o_orderkey', ['Positive', '150 mg/dL', 'Not Detected', '30.5 mg/dL'])}, chr(10),
        'Cocaine ', {_case('o_orderkey', ['detected', 'negative', '45 ng'])}, chr(10),
        'Brain: ', {_case('o_orderkey', ['congested and edematous', 'nad', 'subdural hematoma on left'])}, chr(10),
        'Heart: ', {_case('o_orderkey', ['left ventricle thick', 'pale'])}, chr(10),
        'Performed by: Dr. ', {_case('o_orderkey', ['Meera Nair', 'Paul Stone'])}, ', MBBS', chr(10),
        'pt brought dead; ', {_case('o_orderkey', ['h/o HTN and DM.', 'GSW to chest, approx 2 cm.', 'heart attack, kneecap swelling', 'no complaints'])},
        ' wt ', CAST(40 + o_orderkey % 60 AS STRING), ' kg') AS text FROM {{orders}}""",
    ),
    "messy": (
        ["documents"],
        """SELECT doc_id, concat('  ', replace(replace(text, 'é', 'e\u0301'), ' ', CASE WHEN doc_id % 3 = 0 THEN concat(chr(9), ' ') WHEN doc_id % 3 = 1 THEN '  ' ELSE ' ' END),
        CASE WHEN doc_id % 2 = 0 THEN concat(chr(13), chr(10), chr(7), 'x ', chr(13), 'y') ELSE concat(' ', chr(10), chr(10), ' end') END, ' ') AS text FROM {documents}""",
    ),
    "metadata": (
        ["orders"],
        f"""SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) * (CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 END) AS file_size,
        {_case('o_orderkey', ['2024-01-15T10:30:00Z', '15 January 2024', 'not a date', '2031-05-01', '1850-01-01', '2024-07', '03/04/2024', ''])} AS creation_date,
        {_case('o_orderkey', ['2024-02-01 08:00:00', '', '13/04/2024'])} AS modification_date,
        {_case('o_orderkey', ['12.5', '0', '95.25', '-33.8688', 'x', ''])} AS lat,
        {_case('o_orderkey', ['77.6', '0', '10', '151.2093', 'y', ''])} AS lon,
        {_case('o_orderkey', ['Canon', '', ''])} AS camera_make,
        {_case('o_orderkey', ['some preview text', ''])} AS preview,
        {_case('o_orderkey', ['', '', '', '', 'reader failed'])} AS error,
        CAST(o_orderkey % 12000 AS INT) AS page_count,
        {_case('o_orderkey', ['a.pdf', 'b.txt', ''])} AS filename FROM {{orders}}""",
    ),
    "measurements": (
        ["lineitem"],
        f"""SELECT l_orderkey AS id, l_linenumber AS n, l_quantity AS value,
        {_case('(l_orderkey + l_linenumber)', ['F', 'lbs', 'oz', 'ft', 'IN', 'yd', 'k', 'cm', 'furlong', ' Stones ', 'gal'])} AS unit,
        {_case('(l_orderkey + l_linenumber)', ['alcohol', 'morphine', 'Valium', 'cocaine', 'meth', 'KCN', 'insecticide', 'cotinine', 'water', 'benzoylecgonine'])} AS substance,
        {_case('(l_orderkey * 3 + l_linenumber)', ['positive', 'NEG', 'trace', 'awaited', 'odd'])} AS result,
        concat(CAST(CAST(l_quantity AS INT) * 17 AS STRING), {_case('(l_orderkey + l_linenumber)', [' mg/dl', ' units', ''])}) AS concentration,
        {_case('(l_orderkey + l_linenumber)', ['mg/dl', 'NG/ML', 'percent', 'iu'])} AS conc_unit FROM {{lineitem}}""",
    ),
    "words": (
        ["documents"],
        """SELECT doc_id, CAST(k / 60 AS INT) AS page, CAST((k % 60) / 10 AS INT) AS line, CAST(k % 10 AS INT) AS seq, w AS word,
        CAST((doc_id * 7 + k * 13) % 101 - 1 AS INT) AS conf, CAST(40 * (k % 10) AS INT) AS x, CAST(30 * ((k % 60) / 10) AS INT) AS y,
        CAST(5 * length(w) AS INT) AS w, CAST(12 + k % 3 AS INT) AS h
        FROM (SELECT doc_id, CAST(pos AS BIGINT) AS k, w FROM {exploded}) AS e WHERE w <> ''""",
    ),
    "regions": (
        ["lineitem"],
        """SELECT l_orderkey AS page, l_linenumber AS seq, CAST((l_partkey * 37) % 900 AS INT) AS x, CAST((l_partkey * 53) % 1200 AS INT) AS y,
        CAST(30 + (l_partkey * 7) % 700 AS INT) AS w, CAST(12 + (l_suppkey * 5) % 160 AS INT) AS h, l_discount * 6 AS stroke, l_tax * 2 AS edges FROM {lineitem}""",
    ),
}


#: Views whose queries are heavy in CPU, with the columns that they read.
HEAVY = {
    "reports": ["o_orderkey"],
    "metadata": ["o_orderkey", "o_totalprice"],
    "measurements": ["l_orderkey", "l_linenumber", "l_quantity"],
    "messy": ["doc_id", "text"],
}


def view(spark: SparkSession, sf_dir: str, name: str, docs: DataFrame | None = None) -> DataFrame:
    """The view in Spark; ``docs``: words of these documents alone."""
    tables, sql = VIEWS[name]
    if name == "words":
        docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")) if docs is None else docs
        exploded = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
        return spark.sql(sql.replace("k / 60", "k div 60").replace("(k % 60) / 10", "(k % 60) div 10"), exploded=exploded)
    if name in HEAVY:
        even = spread if name == "messy" else deal  # texts are split by their bytes, keys are not
        return spark.sql(sql, **{t: even(table(spark, sf_dir, t).select(*HEAVY[name])) for t in tables})
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def once_and_repeated(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``df`` whose key no other row has, and the others (None if there are none); only keys are shuffled."""
    again = materialize(df.groupBy(key).count().where("count > 1").select(key), "repeated")
    if again.isEmpty():
        return df, None
    again = broadcast_if_small(again.select(F.col(key).alias("again")))
    same = F.col(key).eqNullSafe(F.col("again"))
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def words_of_pages(text: Column, doc_id: Column) -> Column:
    """The words view of one text as an array of pages (page, lines) of lines (line, words)."""

    def word(w: Column, k: Column, line: Column) -> Column:
        conf, x = (doc_id * 7 + k * 13) % 101, k % 10
        return F.struct(w.alias("word"), (conf - 1).cast("int").alias("conf"), (x * 40).cast("int").alias("x"), (line * 30).cast("int").alias("y"), (F.length(w) * 5).alias("w"), (k % 3 + 12).cast("int").alias("h"))

    def line(ws: Column, page: Column, at: Column) -> Column:
        k = page * 60 + at * 10
        words = F.transform(F.slice(ws, (k + 1).cast("int"), F.lit(10)), lambda w, j: word(w, k + j, at))
        return F.struct(at.cast("int").alias("line"), words.alias("words"))

    lines = lambda ws, page: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda at: line(ws, page, at.cast("long")))
    page = lambda ws, p: F.struct(p.cast("int").alias("page"), lines(ws, p).alias("lines"))
    return bind(F.split(text, " "), lambda ws: F.transform(F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / 60).cast("int")), lambda p: page(ws, p.cast("long"))))


def duck(name: str) -> str:
    """The view as a DuckDB subquery."""
    tables, sql = VIEWS[name]
    sql = sql.replace("AS STRING", "AS VARCHAR")
    if name == "words":
        sql = sql.replace("k / 60", "k // 60").replace("(k % 60) / 10", "(k % 60) // 10")
        return "(" + sql.replace("{exploded}", "(SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS w FROM (SELECT doc_id, string_split(text, ' ') AS p FROM documents) AS s)") + ")"
    for t in tables:
        sql = sql.replace("{" + t + "}", t)
    return f"({sql})"


def rows(table_rows: list[tuple], names: str) -> str:
    """A small fixed table for DuckDB."""
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in table_rows) + f") AS t({names})"
