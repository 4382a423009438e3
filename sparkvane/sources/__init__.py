"""Where records come from and go to: the log, frame files, uploads."""
