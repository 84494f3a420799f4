"""A PySpark engine for the data work of a multi-tenant knowledge and prompt platform."""
