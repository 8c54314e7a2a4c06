"""Document-local operators (plain Python over one text) and relational ones (DataFrame to DataFrame)."""
