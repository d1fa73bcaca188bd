"""Training-data operators: each module holds one operator over a documents or pages table."""
