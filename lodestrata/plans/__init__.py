"""Query catalogue on the driver's tables, with the SQL each is checked against."""
