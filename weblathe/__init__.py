"""weblathe: web-access evidence analytics and training-data preparation on PySpark."""
