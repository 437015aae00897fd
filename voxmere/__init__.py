"""voxmere: volumetric analytics expressed as Spark DataFrame and SQL plans."""
