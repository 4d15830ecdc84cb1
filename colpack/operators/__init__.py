"""DataFrame operators: block and typed columns, framed streams, generators and recipes."""
