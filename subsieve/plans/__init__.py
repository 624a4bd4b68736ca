"""Registered queries over the given tables, each with its SQL."""

from . import audit, files, clusters, profiles, scenes, tables

MODULES = [audit, files, tables, profiles, scenes, clusters]
