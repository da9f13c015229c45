"""Column-level functions: null rules, recodes and column selectors."""
