"""loomtext: long-form text analytics expressed as Spark DataFrame plans."""
