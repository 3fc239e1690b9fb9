"""Fixed lookup tables: shipped rules, checklists, labels."""
