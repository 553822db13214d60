"""Operators on training text: sharding, token files, quality, tokens, licences, leaks, languages, secrets, copies."""
