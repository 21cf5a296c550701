"""What runs: the store, the phases of a run, exports, configuration and the command line."""
