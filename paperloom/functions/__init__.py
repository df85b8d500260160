"""Column functions, vocabularies and canonical identities."""
