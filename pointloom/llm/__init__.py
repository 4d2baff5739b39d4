"""Training-data operators: each module holds one operator with a general interface."""
