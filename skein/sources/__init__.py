"""Sources of skein."""
