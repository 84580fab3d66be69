"""Evidence fusion and data-processing operators as PySpark DataFrame plans."""
