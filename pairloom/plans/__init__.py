"""Compositions of operators, one function per job."""
