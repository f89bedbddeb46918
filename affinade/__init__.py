"""affinade: recommendation analytics declared as Spark plans."""
