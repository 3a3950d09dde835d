"""Queries over the given tables, each with the SQL that checks it."""


def registries():
    from . import fields, grids, signals, stored, studies, traces

    return [signals.reg, traces.reg, grids.reg, fields.reg, stored.reg, studies.reg]
