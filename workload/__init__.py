"""The library's operators run over the driver's tables, with SQL to compare."""
