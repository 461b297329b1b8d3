"""Jobs made of operators, and the registry of queries with their check SQL."""
