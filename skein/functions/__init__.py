"""Functions of skein."""
