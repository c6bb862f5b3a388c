"""Registered queries: each one is a Spark job over whole tables and, where SQL can say it, the same
question in SQL for checking."""
