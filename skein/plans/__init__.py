"""Plans of skein."""
