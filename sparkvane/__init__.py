"""sparkvane: data exploration, validation and text-corpus operators as Spark plans."""
