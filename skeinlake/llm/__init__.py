"""Training-data operators: ten corpus operators, their registered queries and their SQL."""
