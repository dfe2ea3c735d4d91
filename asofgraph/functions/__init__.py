"""See the module list in README.md."""
