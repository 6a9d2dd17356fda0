"""The registered queries and, written independently, the SQL they are checked against."""
