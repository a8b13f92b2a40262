"""kinspark: pedigree inference and table analytics expressed as Spark plans."""
