"""A Spark-first analytics engine for postings, companies, contacts and their event histories."""
