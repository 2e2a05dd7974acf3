"""Registered queries. Importing this package fills the registry."""
