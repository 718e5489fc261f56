"""Plans made of the operators: signals, scores, history, labels and learning."""
