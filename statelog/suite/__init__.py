"""The registered queries, their SQL, and the mapping of the test tables to state vectors."""
