"""Where pages, raw files, logs and change feeds are read from."""
