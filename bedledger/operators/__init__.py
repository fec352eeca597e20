"""Frame-to-frame operators: cleaning, upserts, checks, loads, bed roll-ups."""
