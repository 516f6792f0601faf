"""Evidence analytics over large document collections, as Spark DataFrame operators."""
