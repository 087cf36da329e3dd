"""Functions of the engine; see the README for the map from operator to module."""
