"""Plan shapes that keep ordered work distributed when keys are skewed."""
