"""seekwell: search and analytics over web documents, written as Spark DataFrame plans."""
