"""Training-data operators: each module holds one operator, its thin query and what SQL can say of it."""
