"""Training-data operators: the ten pipeline components and their queries."""
