"""Scalar column functions (JVM-side ``pyspark.sql.functions`` compositions) reproducing the reference's
text, number and date conventions, and the values it fixes."""
