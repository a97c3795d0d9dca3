"""Readers and writers of tables that travel as files, and checks of their columns."""
