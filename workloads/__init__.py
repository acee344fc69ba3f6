"""The library's operators bound to the driver's tables, with the SQL to check them."""
