"""Frame-stream and geometric analytics as PySpark DataFrame operators."""
