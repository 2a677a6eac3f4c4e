"""The check world derived from the TPC-H-like tables, the queries and their SQL twins."""
