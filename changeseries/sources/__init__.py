"""Readers: change-log and label files, JDBC queries."""
