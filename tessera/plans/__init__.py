"""The registered queries, each with its SQL, over the tables of ``model``."""
