"""dossier: evidence analytics expressed as Spark DataFrame transformations."""
