"""quillon: lazy PySpark operators for reads, tracks, pixels, curves and oligo design tables."""
