"""Column functions: sequences, geometry, text, small rules. All built from Spark functions, none from Python code per row."""
