"""Registered queries over the star schema, with their SQL."""

from . import exchange, geo, relational

CATALOGUE = geo.QUERIES | relational.QUERIES | exchange.QUERIES
CATALOGUE["geo_vincenty"] = CATALOGUE["geo_vincenty"][0], exchange.VINCENTY


def queries():
    return {name: f for name, (f, _) in CATALOGUE.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql is not None}
