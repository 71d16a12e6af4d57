"""Lets tests import the package from the repository's top."""
