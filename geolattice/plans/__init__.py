"""Objects that hold the stages of an analysis: the geometry cache and the method registries."""
