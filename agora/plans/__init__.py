"""Query plans: master frame, script-style analyses, SQL-style queries."""
