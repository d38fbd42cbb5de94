"""General relational operators. Every function takes column names and works on any table."""
