"""Order-book operators. `sql.Operator` holds one relational operator; `stateful` and `dense` hold what SQL cannot say."""
