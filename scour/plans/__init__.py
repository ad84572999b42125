"""Recipes (fitted parameters, audit log, replay) and the layer compositions."""
