"""tallyforge: a Spark-first engine for reported figures and the documents that print them."""
