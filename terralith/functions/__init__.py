"""Column functions: values of tags, labels and geometry."""
