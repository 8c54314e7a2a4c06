"""Column functions: matches with offsets, validators, dates, ages and postcodes, all on the JVM."""
