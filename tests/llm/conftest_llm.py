"""Helpers of the tests of this folder."""

import hashlib


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rows_of(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}
