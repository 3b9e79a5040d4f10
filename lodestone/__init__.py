"""Knowledge-base retrieval and support analytics as Spark DataFrame operators."""
