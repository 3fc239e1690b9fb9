"""Readers: corpus files, rule tables, advisories, truth labels, lockfiles."""
