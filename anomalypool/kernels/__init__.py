"""Signal processing on one series at a time, in numpy, for grouped and mapped functions."""
