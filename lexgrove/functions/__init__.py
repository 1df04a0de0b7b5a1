"""Column functions: every one maps Columns to a Column."""
