"""Registered queries over the driver's tables, each module with QUERIES and ORACLE."""

from foliant.queries import answers, derived, documents, evaluation, pages, training

MODULES: list = [documents, pages, answers, evaluation, derived, training]
