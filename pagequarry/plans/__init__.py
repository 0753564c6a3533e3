"""Query catalogues: name -> (callable, oracle SQL or None)."""
