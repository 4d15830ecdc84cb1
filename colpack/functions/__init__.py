"""The codec core in plain Python, and native column expressions over its bytes."""
