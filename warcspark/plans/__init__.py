"""Registered queries over the driver's tables, with the SQL that states what they must return."""
