"""Training-data operators: one module for each, and their registered queries in ``queries``."""
