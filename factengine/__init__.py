"""factengine: financial-fact tables as PySpark DataFrame jobs."""
