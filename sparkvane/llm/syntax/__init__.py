"""Parsers of bundled grammars: a chart parser over token streams, its grammars, and scanners."""
