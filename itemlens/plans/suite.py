"""All registered queries and their SQL."""

from itemlens.plans import cleaning, counting, files, network, outside, people, results, texts

SUITES = [counting.suite, cleaning.suite, texts.suite, people.suite, outside.suite, network.suite, results.suite, files.suite]


def queries():
    return {name: fn for s in SUITES for name, fn in s.queries.items()}


def oracle_sql():
    return {name: sql for s in SUITES for name, sql in s.sql.items()}
