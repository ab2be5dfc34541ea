"""Jobs composed from the operators: population, housing, education, exploration."""
