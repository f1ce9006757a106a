"""Column builders: text in, typed columns out, all planned by Catalyst."""
