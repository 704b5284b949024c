"""Graph operators: cleaning, neighbourhoods, features, dynamics, targets, statistics."""
