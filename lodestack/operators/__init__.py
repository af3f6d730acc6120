"""DataFrame operators: tables to tables, in built-in expressions."""
