"""What a plan leaves behind: report files, trash, exported copies."""
