"""Dialect normalisation on tokens: the text that reaches Spark's parser is Spark SQL."""

from framesql.dialect.rewrite import DIALECTS, Rewritten, rewrite
from framesql.dialect.tokens import Token, tokenize

__all__ = ["DIALECTS", "Rewritten", "Token", "rewrite", "tokenize"]
